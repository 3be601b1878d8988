"""Metrics that are expressions over sums: each names the sums it needs of a row's label, prediction and weight, and its
value over them. Metrics that need the same sum share it; all sums of all metrics are one aggregation."""

from __future__ import annotations

import re
from collections.abc import Callable, Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column
from pyspark.sql import functions as F

from metricloom.functions.scalars import above, div, div_far, nan


@dataclass(frozen=True)
class Row:
    """Columns of one input of a metric; ``other`` is the baseline model's prediction in comparisons."""

    label: Column
    prediction: Column
    weight: Column
    other: Column | None = None


@dataclass(frozen=True)
class Metric:
    name: str
    states: dict[str, Callable[[Row], Column]]
    value: Callable[[dict[str, Column]], Column]
    kinds: dict[str, str] = field(default_factory=dict)
    #: False for metrics without confidence intervals.
    intervals: bool = True


@dataclass(frozen=True)
class Derived:
    """A metric over other metrics' values of the same slice, model and sub-key.

    ``needs``: names of these as results have them, derived ones included; ``value`` over them, or ``sql`` that speaks of
    them by name. ``helpers``: metrics, by name and parameters, that it brings along; they are shared with equal ones and
    hidden unless they are configured. At the stage ``intervals`` a needed metric is a struct with ``value``,
    ``sample_mean``, ``standard_error``, ``lower`` and ``upper``; at ``values`` it is a number, in each sample anew.
    """

    name: str
    needs: tuple[str, ...]
    value: Callable[[dict[str, Column]], Column] | None = None
    sql: str | None = None
    helpers: tuple[tuple[str, dict], ...] = ()
    stage: str = "values"
    intervals: bool = True

    def column(self, quoted: dict[str, str]) -> Column:
        """The value, where each needed metric stands in a column of a given quoted name."""
        if self.sql is None:
            return self.value({n: F.col(q) for n, q in quoted.items()})
        return F.expr(renamed(self.sql, quoted))


@dataclass(frozen=True)
class CrossSlice:
    """A function of two slices: over the needed metrics' values in either, as ``base`` and ``other``."""

    name: str
    needs: tuple[str, ...]
    value: Callable[[Column, Column], Column] | None = None
    sql: str | None = None
    helpers: tuple[tuple[str, dict], ...] = ()
    intervals: bool = True

    def column(self) -> Column:
        """The value over structs ``base`` and ``other``."""
        return F.expr(self.sql) if self.sql is not None else self.value(F.col("base"), F.col("other"))


def renamed(sql: str, names: dict[str, str]) -> str:
    """SQL with column names, plain or in backquotes, replaced; strings and functions stay."""

    def put(m: re.Match) -> str:
        return names.get(m[0].strip("`"), m[0]) if m[0][0] != "'" else m[0]

    return re.sub(r"'(?:[^'\\]|\\.)*'|`[^`]+`|(?<![\w.])[A-Za-z_]\w*(?![\w(])", put, sql)


REGISTRY: dict[str, Callable[..., Metric | Derived | CrossSlice]] = {}


def register(name: str, *aliases: str) -> Callable:
    """Make a metric known by name to configurations; users register their own in the same way."""

    def add(factory: Callable[..., Metric]) -> Callable[..., Metric]:
        for n in (name, *aliases):
            REGISTRY[n] = factory
        return factory

    return add


def make(name: str, **params) -> Metric | Derived | CrossSlice:
    if name not in REGISTRY:
        raise ValueError(f"unknown metric {name}")
    return REGISTRY[name](**params)


@register("Expression")
def expression(sql: str, needs: Sequence[str], name: str = "Expression", stage: str = "values") -> Derived:
    """A metric that a configuration writes in SQL over other metrics' names."""
    if stage not in ("values", "intervals"):
        raise ValueError("a derived metric is of values or of intervals")
    return Derived(name, tuple(needs), sql=sql, stage=stage)


@register("CrossExpression")
def cross_expression(sql: str, needs: Sequence[str], name: str = "CrossExpression") -> CrossSlice:
    """A function of two slices in SQL over ``base.name`` and ``other.name``."""
    return CrossSlice(name, tuple(needs), sql=sql)


# --- confusion matrices at a threshold -------------------------------------------------------------------------------


def cell(kind: str, threshold: float) -> tuple[str, Callable[[Row], Column]]:
    """A cell's name and sum: positive above the threshold; a label between 0 and 1 counts in part for either class."""
    positive = kind in ("tp", "fp")

    def amount(r: Row) -> Column:
        hit = above(r.prediction, threshold) if positive else ~above(r.prediction, threshold)
        return F.when(hit, r.weight * (r.label if kind in ("tp", "fn") else 1 - r.label)).otherwise(0.0)

    return f"{kind}@{threshold:g}", amount


def _at(name: str, threshold: float) -> str:
    return name if threshold == 0.5 else f"{name}@{threshold:g}"


def _both(cond: Column, value: Column) -> Column:
    return F.when(cond, value).otherwise(nan())


def _rates(tp: Column, tn: Column, fp: Column, fn: Column) -> tuple[Column, Column, Column]:
    return tp / (tp + fn), tn / (tn + fp), (tp + fn > 0) & (tn + fp > 0)


def _prevalence_threshold(tp, tn, fp, fn):
    tpr, tnr, ok = _rates(tp, tn, fp, fn)
    return F.when(ok & (tpr + tnr != 1), (F.sqrt(F.greatest(F.lit(0.0), tpr * (1 - tnr))) + tnr - 1) / (tpr + tnr - 1)).otherwise(nan())


def _mcc(tp, tn, fp, fn):
    return div(tp * tn - fp * fn, F.sqrt((tp + fp) * (tp + fn) * (tn + fp) * (tn + fn)))


def _odds(tp, tn, fp, fn):
    return _both((fn > 0) & (tn > 0) & (fp > 0), (tp / fn) / (fp / tn))


def _all(*cells: Column) -> Column:
    out = cells[0]
    for c in cells[1:]:
        out = out + c
    return out


#: Names of point metrics, each over the four cells.
POINTS: dict[str, Callable[..., Column]] = {
    "TruePositives": lambda tp, tn, fp, fn: tp,
    "TrueNegatives": lambda tp, tn, fp, fn: tn,
    "FalsePositives": lambda tp, tn, fp, fn: fp,
    "FalseNegatives": lambda tp, tn, fp, fn: fn,
    "BinaryAccuracy": lambda tp, tn, fp, fn: div(tp + tn, _all(tp, tn, fp, fn)),
    "Precision": lambda tp, tn, fp, fn: div(tp, tp + fp),
    "Recall": lambda tp, tn, fp, fn: div(tp, tp + fn),
    "Specificity": lambda tp, tn, fp, fn: div(tn, tn + fp),
    "FallOut": lambda tp, tn, fp, fn: div(fp, fp + tn),
    "MissRate": lambda tp, tn, fp, fn: div(fn, fn + tp),
    "NegativePredictiveValue": lambda tp, tn, fp, fn: div(tn, tn + fn),
    "FalseDiscoveryRate": lambda tp, tn, fp, fn: div(fp, fp + tp),
    "FalseOmissionRate": lambda tp, tn, fp, fn: div(fn, fn + tn),
    "Prevalence": lambda tp, tn, fp, fn: div(tp + fn, _all(tp, tn, fp, fn)),
    "PrevalenceThreshold": _prevalence_threshold,
    "ThreatScore": lambda tp, tn, fp, fn: div(tp, tp + fn + fp),
    "BalancedAccuracy": lambda tp, tn, fp, fn: _both((tp + fn > 0) & (tn + fp > 0), (tp / (tp + fn) + tn / (tn + fp)) / 2),
    "F1Score": lambda tp, tn, fp, fn: div(2 * tp, 2 * tp + fp + fn),
    "MatthewsCorrelationCoefficient": _mcc,
    "FowlkesMallowsIndex": lambda tp, tn, fp, fn: _both((tp + fp > 0) & (tp + fn > 0), F.sqrt(tp / (tp + fp) * (tp / (tp + fn)))),
    "Informedness": lambda tp, tn, fp, fn: _both((tp + fn > 0) & (tn + fp > 0), tp / (tp + fn) + tn / (tn + fp) - 1),
    "Markedness": lambda tp, tn, fp, fn: _both((tp + fp > 0) & (tn + fn > 0), tp / (tp + fp) + tn / (tn + fn) - 1),
    "PositiveLikelihoodRatio": lambda tp, tn, fp, fn: _both((tp + fn > 0) & (fp > 0) & (tn + fp > 0), (tp / (tp + fn)) / (fp / (fp + tn))),
    "NegativeLikelihoodRatio": lambda tp, tn, fp, fn: _both((tp + fn > 0) & (tn > 0) & (tn + fp > 0), (fn / (tp + fn)) / (tn / (tn + fp))),
    "DiagnosticOddsRatio": _odds,
    "PredictedPositiveRate": lambda tp, tn, fp, fn: div(tp + fp, _all(tp, tn, fp, fn)),
}
#: Other names of point metrics.
ALIASES = {
    "TP": "TruePositives", "TN": "TrueNegatives", "FP": "FalsePositives", "FN": "FalseNegatives", "PPV": "Precision", "TPR": "Recall",
    "TNR": "Specificity", "FPR": "FallOut", "FNR": "MissRate", "NPV": "NegativePredictiveValue",
}


def _point(name: str, formula: Callable[..., Column]) -> Callable[..., Metric]:
    def factory(threshold: float = 0.5) -> Metric:
        cells = [cell(kind, threshold) for kind in ("tp", "tn", "fp", "fn")]
        return Metric(_at(name, threshold), dict(cells), lambda s: formula(*(s[n] for n, _ in cells)))

    return factory


for _name, _formula in POINTS.items():
    register(_name, *(a for a, n in ALIASES.items() if n == _name))(_point(_name, _formula))


@register("MaxRecall")
def max_recall() -> Metric:
    made = make("Recall", threshold=1e-12)
    return Metric("MaxRecall", made.states, made.value)


# --- counts, means, calibration ---------------------------------------------------------------------------------------

WEIGHT = {"w": lambda r: r.weight}
LABEL = {"wl": lambda r: r.weight * r.label}
PREDICTION = {"wp": lambda r: r.weight * r.prediction}


@register("ExampleCount", "WeightedExampleCount")
def example_count() -> Metric:
    return Metric("ExampleCount", WEIGHT, lambda s: s["w"])


@register("MeanLabel")
def mean_label() -> Metric:
    return Metric("MeanLabel", WEIGHT | LABEL, lambda s: div_far(s["wl"], s["w"]))


@register("MeanPrediction")
def mean_prediction() -> Metric:
    return Metric("MeanPrediction", WEIGHT | PREDICTION, lambda s: div_far(s["wp"], s["w"]))


@register("Calibration")
def calibration() -> Metric:
    return Metric("Calibration", LABEL | PREDICTION, lambda s: div_far(s["wp"], s["wl"]))


@register("Mean")
def mean(column: str) -> Metric:
    """The weighted mean of a feature; rows where it is null or NaN do not count."""
    held = lambda r, x: F.when(F.col(column).isNotNull() & ~F.isnan(F.col(column).cast("double")), x).otherwise(0.0)
    return Metric(f"Mean({column})", {f"w|{column}": lambda r: held(r, r.weight), f"wx|{column}": lambda r: held(r, r.weight * F.col(column))}, lambda s: div(s[f"wx|{column}"], s[f"w|{column}"]))


# --- regression, losses, correlation ----------------------------------------------------------------------------------


def _mean_error(name: str, error: Callable[[Row], Column]) -> Metric:
    """The weighted mean of a row's error; rows whose error is NaN or null count in neither sum."""
    ok = lambda r: error(r).isNotNull() & ~F.isnan(error(r))
    return Metric(name, {f"e|{name}": lambda r: F.when(ok(r), r.weight * error(r)).otherwise(0.0), f"w|{name}": lambda r: F.when(ok(r), r.weight).otherwise(0.0)}, lambda s: div(s[f"e|{name}"], s[f"w|{name}"]))


@register("MeanAbsoluteError")
def mean_absolute_error() -> Metric:
    return _mean_error("MeanAbsoluteError", lambda r: F.abs(r.label - r.prediction))


@register("MeanSquaredError")
def mean_squared_error() -> Metric:
    return _mean_error("MeanSquaredError", lambda r: (r.label - r.prediction) * (r.label - r.prediction))


@register("MeanAbsolutePercentageError")
def mean_absolute_percentage_error() -> Metric:
    return _mean_error("MeanAbsolutePercentageError", lambda r: F.when(r.label != 0, 100 * F.abs((r.label - r.prediction) / r.label)))


@register("MeanSquaredLogarithmicError")
def mean_squared_logarithmic_error() -> Metric:
    return _mean_error("MeanSquaredLogarithmicError", lambda r: F.pow(F.log(r.label + 1) - F.log(r.prediction + 1), 2))


@register("BinaryCrossEntropy")
def binary_cross_entropy(from_logits: bool = False, label_smoothing: float = 0.0) -> Metric:
    """Mean of -l ln p - (1-l) ln(1-p), infinite where certainty is wrong; from logits in the stable form."""

    def loss(r: Row) -> Column:
        label = r.label * (1 - label_smoothing) + 0.5 * label_smoothing
        if from_logits:
            return F.greatest(r.prediction, F.lit(0.0)) - r.prediction * label + F.log1p(F.exp(-F.abs(r.prediction)))
        term = lambda a, p: F.when(a == 0, 0.0).when(p > 0, -a * F.log(p)).when(p == 0, F.lit(float("inf")) * F.signum(a))
        return term(label, r.prediction) + term(1 - label, 1 - r.prediction)

    return _mean_error("BinaryCrossEntropy", loss)


@register("CategoricalCrossEntropy")
def categorical_cross_entropy(from_logits: bool = False, label_smoothing: float = 0.0) -> Metric:
    """Mean of -sum l ln(p / sum p) over arrays; classes with p = 0 add nothing."""

    def loss(r: Row) -> Column:
        p = F.transform(r.prediction, lambda x: F.exp(x)) if from_logits else r.prediction
        total = F.aggregate(p, F.lit(0.0), lambda a, x: a + x)
        n = F.size(r.label)
        terms = F.zip_with(r.label, p, lambda a, x: F.when(x > 0, -(a * (1 - label_smoothing) + label_smoothing / n) * F.log(x / total)).otherwise(0.0))
        return F.aggregate(terms, F.lit(0.0), lambda a, x: a + x)

    return _mean_error("CategoricalCrossEntropy", loss)


@register("SquaredPearsonCorrelation")
def squared_pearson_correlation() -> Metric:
    sums = WEIGHT | LABEL | PREDICTION | {"wll": lambda r: r.weight * r.label * r.label, "wpp": lambda r: r.weight * r.prediction * r.prediction, "wlp": lambda r: r.weight * r.label * r.prediction}

    def value(s: dict[str, Column]) -> Column:
        n = s["w"]
        cross = s["wlp"] - s["wl"] * s["wp"] / n
        spread = (s["wll"] - s["wl"] * s["wl"] / n) * (s["wpp"] - s["wp"] * s["wp"] / n)
        return F.when((n > 0) & (spread > 0), cross * cross / spread).otherwise(nan())

    return Metric("SquaredPearsonCorrelation", sums, value)


TJUR = WEIGHT | LABEL | PREDICTION | {"wlp": lambda r: r.weight * r.label * r.prediction}


@register("CoefficientOfDiscrimination")
def coefficient_of_discrimination() -> Metric:
    return Metric("CoefficientOfDiscrimination", TJUR, lambda s: div(s["wlp"], s["wl"]) - div(s["wp"] - s["wlp"], s["w"] - s["wl"]))


@register("RelativeCoefficientOfDiscrimination")
def relative_coefficient_of_discrimination() -> Metric:
    return Metric("RelativeCoefficientOfDiscrimination", TJUR, lambda s: div(div(s["wlp"], s["wl"]), div(s["wp"] - s["wlp"], s["w"] - s["wl"])))


@register("ExactMatch")
def exact_match(convert_to: str | None = None) -> Metric:
    """Share of rows whose prediction equals the label; with ``json`` both are compared as parsed documents."""

    def same(r: Row) -> Column:
        if convert_to == "json":
            form = lambda c: F.to_json(F.try_parse_json(c))
            return F.coalesce(form(r.label) == form(r.prediction), F.lit(False))
        return F.coalesce(r.label == r.prediction, F.lit(False))

    return Metric("ExactMatch", WEIGHT | {f"same|{convert_to}": lambda r: F.when(same(r), r.weight).otherwise(0.0)}, lambda s: div(s[f"same|{convert_to}"], s["w"]))


@register("Accuracy")
def accuracy() -> Metric:
    """Share of rows with equal label and prediction, as numbers."""
    return Metric("Accuracy", WEIGHT | {"equal": lambda r: F.when(r.label == r.prediction, r.weight).otherwise(0.0)}, lambda s: div(s["equal"], s["w"]))


def _best(values: Column) -> Column:
    return F.array_position(values, F.array_max(values)) - 1


@register("CategoricalAccuracy")
def categorical_accuracy() -> Metric:
    """Share of rows whose best class is that of the one-hot label."""
    return Metric("CategoricalAccuracy", WEIGHT | {"best": lambda r: F.when(_best(r.label) == _best(r.prediction), r.weight).otherwise(0.0)}, lambda s: div(s["best"], s["w"]))


@register("SparseCategoricalAccuracy")
def sparse_categorical_accuracy() -> Metric:
    """Share of rows whose best class is the label."""
    return Metric("SparseCategoricalAccuracy", WEIGHT | {"best sparse": lambda r: F.when(r.label.cast("long") == _best(r.prediction), r.weight).otherwise(0.0)}, lambda s: div(s["best sparse"], s["w"]))


@register("Loss")
def loss(column: str) -> Metric:
    """The weighted mean of a loss that a column holds."""
    made = mean(column)
    return Metric("Loss", made.states, made.value)


# --- two models on one row --------------------------------------------------------------------------------------------


@register("SymmetricPredictionDifference")
def symmetric_prediction_difference() -> Metric:
    def gap(r: Row) -> Column:
        near = (F.abs(r.other) < 1e-7) & (F.abs(r.prediction) < 1e-7)
        return F.when(near, 0.0).otherwise(2 * F.abs(r.other - r.prediction) / F.abs(r.other + r.prediction))

    return Metric("SymmetricPredictionDifference", WEIGHT | {"gap": lambda r: r.weight * gap(r)}, lambda s: div(s["gap"], s["w"]))


def _flip(kind: tuple[bool, bool], threshold: float) -> dict[str, Callable[[Row], Column]]:
    def amount(r: Row) -> Column:
        before, after = above(r.other, threshold), above(r.prediction, threshold)
        return F.when((before if kind[0] else ~before) & (after if kind[1] else ~after), r.weight).otherwise(0.0)

    return {f"flip{int(kind[0])}{int(kind[1])}@{threshold:g}": amount}


#: Flip rates by name: the baseline's class and the candidate's.
FLIPS = {"NegToNegFlipRate": (False, False), "NegToPosFlipRate": (False, True), "PosToNegFlipRate": (True, False), "PosToPosFlipRate": (True, True)}


def _flip_rate(name: str, kind: tuple[bool, bool]) -> Callable[..., Metric]:
    def factory(threshold: float = 0.5) -> Metric:
        states = _flip(kind, threshold)
        return Metric(_at(name, threshold), WEIGHT | states, lambda s: div(s[next(iter(states))], s["w"]))

    return factory


for _name, _kind in FLIPS.items():
    register(_name)(_flip_rate(_name, _kind))


@register("SymmetricFlipRate")
def symmetric_flip_rate(threshold: float = 0.5) -> Metric:
    states = _flip((False, True), threshold) | _flip((True, False), threshold)
    return Metric(_at("SymmetricFlipRate", threshold), WEIGHT | states, lambda s: div(_all(*(s[n] for n in states)), s["w"]))


def boolean_flip_rates(threshold: float = 0.5) -> list[Metric]:
    """All five flip rates."""
    return [make(n, threshold=threshold) for n in (*FLIPS, "SymmetricFlipRate")]


@register("ModelCosineSimilarity")
def model_cosine_similarity() -> Metric:
    """Mean over rows, unweighted, of the cosine between two models' prediction vectors."""

    def dot(a: Column, b: Column) -> Column:
        return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)

    def cosine(r: Row) -> Column:
        return div(dot(r.other, r.prediction), F.sqrt(dot(r.other, r.other)) * F.sqrt(dot(r.prediction, r.prediction)))

    return Metric("ModelCosineSimilarity", {"rows": lambda r: F.lit(1.0), "cosine": cosine}, lambda s: div(s["cosine"], s["rows"]))


#: Metrics that compare two models; they have no difference of their own.
PAIRED = {"SymmetricPredictionDifference", "SymmetricFlipRate", *FLIPS, "ModelCosineSimilarity"}


# --- over other metrics -----------------------------------------------------------------------------------------------


@register("FBeta")
def f_beta(beta: float = 1.0, threshold: float = 0.5) -> Derived:
    """The weighted harmonic mean of precision and recall, over these two as metrics of their own."""
    p, r = _at("Precision", threshold), _at("Recall", threshold)
    helpers = tuple((n, {"threshold": threshold}) for n in ("Precision", "Recall"))
    return Derived(_at(f"F{beta:g}", threshold), (p, r), lambda s: div((1 + beta**2) * s[p] * s[r], beta**2 * s[p] + s[r]), helpers=helpers)


@register("RelativeError")
def relative_error(metric: str) -> Derived:
    """How wide a metric's interval is against its value: half the interval over the value."""
    return Derived(f"RelativeError({metric})", (metric,), lambda s: div((s[metric]["upper"] - s[metric]["lower"]) / 2, F.abs(s[metric]["value"])), stage="intervals")


@register("RateRatio")
def rate_ratio(metric: str) -> CrossSlice:
    """A metric of the compared slice over that of the base slice."""
    return CrossSlice(f"RateRatio({metric})", (metric,), lambda base, other: div(other[metric], base[metric]))


@register("ProportionTest")
def proportion_test() -> CrossSlice:
    """The z statistic of two slices' shares of positive labels with the pooled share, over both slices' sums."""
    helpers = (("WeightedExampleCount", {}), ("PositiveWeight", {}))

    def z(base: Column, other: Column) -> Column:
        n, m, x, y = base["ExampleCount"], other["ExampleCount"], base["PositiveWeight"], other["PositiveWeight"]
        pooled = div(x + y, n + m)
        return div(div(x, n) - div(y, m), F.sqrt(pooled * (1 - pooled) * (1 / n + 1 / m)))

    return CrossSlice("ProportionTest", ("ExampleCount", "PositiveWeight"), z, helpers=helpers)


@register("PositiveWeight")
def positive_weight() -> Metric:
    """The sum of weighted labels."""
    return Metric("PositiveWeight", LABEL, lambda s: s["wl"])
